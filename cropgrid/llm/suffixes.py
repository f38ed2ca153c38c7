"""Suffix-array dedup on bytes: strings of LENGTH bytes that start more than once in the corpus.

Every window of LENGTH bytes is owned by one anchor, the run of GRAM bytes in it with the least hash (the leftmost one if several have
it). This depends on the window's content alone, so equal windows have equal anchors at equal places, and only one place in
about 70 has to be sent. Anchors meet by hash. Where the whole stretch of windows that an anchor owns is found again as it is, all
these windows repeat. Where it is not, but the anchor is shared, the stretches of that anchor come together, one of each kind, and a
suffix array of them decides: suffixes are ranked by prefix doubling up to LENGTH bytes, ties stand in order of position, so the
previous smaller position in suffix order with a common prefix of LENGTH is the entry before, and the next one the entry after. A
window with either is a repeat; one with the former is a later copy.

`keep_first` keeps the first copy (by doc_id and position) of every window; without it, all copies go.

Anchors of very many different stretches (more than HOT in a bucket) are not brought together: the hashes of their windows are
counted in an ordinary aggregate with partial sums, which no key can overload.

Defined cases: null or empty texts have no bytes. Texts of fewer than LENGTH bytes keep all. Rows of one doc_id, and rows without
one, are documents of their own; for `keep_first` those without one stand in order of a hash of their text, and rows that are the
same in both columns all keep what the first keeps. Overlapping copies count, within one text too.
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
from cropgrid.session import kept_table

LENGTH, GRAM = 200, 64
REACH = LENGTH - GRAM + 1
SLICE = 1 << 20
#: Bytes of stretches that are ranked at a time, and stretches of one anchor that are ranked together at most.
RANKED, HOT = 2 << 20, 20_000
#: Parts of a bucket's keys that are sorted one after the other.
SHARES = 8
WHOLE, OPEN, FIRST, SPREAD = 1, 2, 4, 8


class Anchors:
    """Anchors of all texts of a slice: place, first and last owned window, hash, hash of the owned stretch, text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.rolling = tb.Rolling(data)
        grams = len(data) - GRAM + 1
        windows = len(data) - LENGTH + 1
        if windows <= 0:
            self.at = self.low = self.high = self.text = np.zeros(0, np.int64)
            self.key = self.stretch = np.zeros(0, np.uint64)
            return
        blocks = -(-grams // REACH)
        padded = np.full(blocks * REACH, np.iinfo(np.uint64).max, np.uint64)
        padded[:grams] = (self.rolling.each(GRAM) >> np.uint64(33)) << np.uint64(32)
        padded[:grams] |= np.arange(grams, dtype=np.uint64)
        padded = padded.reshape(blocks, REACH)
        ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        owner = (np.minimum(behind[:windows], ahead[REACH - 1:REACH - 1 + windows]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        del padded, ahead, behind
        start = np.arange(windows)
        text = np.searchsorted(offsets, start, "right") - 1
        valid = start + LENGTH <= offsets[text + 1]
        start, owner, text = start[valid], owner[valid], text[valid]
        new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])]) if len(start) else np.zeros(0, np.int64)
        self.at, self.text, self.low = owner[new], text[new], start[new]
        self.high = start[np.r_[new, len(start)][1:] - 1] if len(start) else self.low
        self.key = self.rolling.of(self.at, self.at + GRAM)
        self.stretch = tb.mix(self.rolling.of(self.low, self.high + LENGTH) + (self.at - self.low).astype(np.uint64))


ENTRY = np.dtype([("key", "<u8"), ("stretch", "<u8"), ("place", "<i8"), ("known", "<i8")])
MARK = np.dtype([("stretch", "<u8"), ("place", "<i8"), ("flags", "<i8")])


def anchors(docs: DataFrame, bits: int) -> DataFrame:
    """Anchors by bucket. Of the copies of a stretch in a slice the first travels; bucket -1 and below tells the others at once."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tb.slices(batches, "text", SLICE):
            found = Anchors(data, offsets)
            n = len(found.at)
            if not n:
                continue
            doc = rows.column("row_id").to_numpy()[found.text]
            place = found.low - offsets[found.text]
            order = np.lexsort((place, doc, found.stretch, found.key))
            key, stretch = found.key[order], found.stretch[order]
            lead = np.r_[True, (key[1:] != key[:-1]) | (stretch[1:] != stretch[:-1])]
            size = np.diff(np.r_[np.flatnonzero(lead), n])
            entry = np.zeros(int(lead.sum()), ENTRY)
            entry["key"], entry["stretch"], entry["place"], entry["known"] = key[lead], stretch[lead], place[order][lead], size > 1
            bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
            yield ex.batch_of(ex.packed(bucket[lead], doc[order][lead], entry, np.zeros(len(entry), bool)))
            if not lead.all():
                mark = np.zeros(n - len(entry), MARK)
                mark["stretch"], mark["place"], mark["flags"] = stretch[~lead], place[order][~lead], WHOLE
                yield ex.batch_of(ex.packed(-1 - bucket[~lead], doc[order][~lead], mark, np.zeros(len(mark), bool)))

    return docs.mapInArrow(each, ex.SCHEMA)


def met(rows: DataFrame) -> DataFrame:
    """row_id and marks: (stretch, place, flags) of the anchors found more than once."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []

        def told() -> pa.RecordBatch:
            kept = [judged(share) for share in range(SHARES)]
            parts.clear()
            return ex.per_doc(*(np.concatenate(x) for x in zip(*kept, strict=True)))

        def judged(share: int) -> tuple[np.ndarray, np.ndarray]:
            """Documents and marks of one share of the bucket's keys, so that only a share of it is sorted at a time."""
            own = [entry["key"] % np.uint64(SHARES) == share for _, entry in parts]
            doc, entry = (np.concatenate([x[mine] for x, mine in zip(xs, own, strict=True)]) for xs in zip(*parts, strict=True))
            order = np.lexsort((entry["place"], doc, entry["stretch"], entry["key"]))
            doc, entry = doc[order], entry[order]
            if not len(doc):
                return doc, np.zeros(0, MARK)
            new_key = np.r_[True, entry["key"][1:] != entry["key"][:-1]]
            lead = new_key | np.r_[True, entry["stretch"][1:] != entry["stretch"][:-1]]
            first = np.flatnonzero(lead)
            size = np.add.reduceat(1 + entry["known"], first)
            kinds = np.diff(np.r_[np.flatnonzero(new_key[first]), len(first)])
            several, spread = np.repeat(kinds > 1, kinds), np.repeat(kinds > HOT, kinds)
            flags = WHOLE * (size > 1) | OPEN * several | SPREAD * (several & spread)
            flags = np.repeat(flags, np.diff(np.r_[first, len(doc)])) & ~np.where(lead, 0, OPEN | SPREAD) | FIRST * lead
            kept = (flags & (WHOLE | OPEN)) > 0
            mark = np.zeros(int(kept.sum()), MARK)
            mark["stretch"], mark["place"], mark["flags"] = entry["stretch"][kept], entry["place"][kept], flags[kept]
            return doc[kept], mark

        for bucket, _, docs, counts, prints in ex.streamed(batches):
            if bucket < 0:
                yield ex.per_doc(*ex.unpacked(docs, counts, prints, MARK))
                continue
            if at != bucket:
                if parts:
                    yield told()
                at = bucket
            parts.append(ex.unpacked(docs, counts, prints, ENTRY))
        if parts:
            yield told()

    return ex.ordered(rows).mapInArrow(each, "doc_id long, marks binary").withColumnRenamed("doc_id", "row_id")


def marked(found: Anchors, offsets: np.ndarray, marks: list[np.ndarray]) -> np.ndarray:
    """Flags of each anchor of the slice."""
    flags = np.zeros(len(found.at), np.int64)
    edge = np.searchsorted(found.text, np.arange(len(offsets)))
    for i, mark in enumerate(marks):
        if len(mark):
            place = {(s, p): f for s, p, f in mark.tolist()}
            for j, s, p in zip(range(edge[i], edge[i + 1]), found.stretch[edge[i]:edge[i + 1]].tolist(),
                               (found.low[edge[i]:edge[i + 1]] - offsets[i]).tolist(), strict=True):
                flags[j] = place.get((s, p), 0)
    return flags


def stretches(texts: DataFrame) -> DataFrame:
    """key, spread, row_id, place and bytes of each stretch that has to be ranked."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tb.slices(batches, "text", SLICE):
            found = Anchors(data, offsets)
            flags = marked(found, offsets, ex.joined_marks(rows.column("marks"), MARK))
            at = np.flatnonzero(flags & OPEN)
            raw = data.tobytes()
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(found.key[at].view(np.int64)), "spread": pa.array((flags[at] & SPREAD) > 0),
                "row_id": pa.array(rows.column("row_id").to_numpy()[found.text[at]], pa.int64()),
                "tag": pa.array(rows.column("tag").to_numpy()[found.text[at]], pa.int64()),
                "place": pa.array(found.low[at] - offsets[found.text[at]], pa.int64()),
                "stretch": pa.array([raw[a:b] for a, b in zip(found.low[at].tolist(), (found.high[at] + LENGTH).tolist(), strict=True)], pa.binary())})

    return texts.mapInArrow(each, "key long, spread boolean, row_id long, tag long, place long, stretch binary")


def ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank in suffix order, cut at `length` bytes, of every place with so many bytes left."""
    n = len(data) - 7
    rank = np.zeros(max(n, 0), np.uint64)
    for j in range(8):
        rank = (rank << np.uint64(8)) | data[j:j + n].astype(np.uint64)
    rank, width = np.unique(rank, return_inverse=True)[1], 8
    while width < length:
        step = min(width, length - width)
        pair = (rank[:-step].astype(np.uint64) << np.uint64(32)) | rank[step:].astype(np.uint64)
        rank, width = np.unique(pair, return_inverse=True)[1], width + step
    return rank


def suffix_neighbours(parts: list[bytes], owners: list[tuple[int, int]]) -> tuple[list[bytes], list[bytes]]:
    """Bits of the windows of each stretch that have an equal one anywhere, and of those with an earlier one (by row and place)."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts], np.int64)
    begin = np.cumsum(size) - size
    count = size - LENGTH + 1
    rank = ranks(data, LENGTH)
    of = np.repeat(np.arange(len(parts)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + begin[of]
    row, place = np.array(owners, np.int64).reshape(-1, 2).T
    position = np.lexsort((start - begin[of] + place[of], row[of], rank[start]))  # the suffix array, ties by position
    suffix = rank[start][position]
    same = np.r_[False, suffix[1:] == suffix[:-1], False]
    any_, earlier = np.zeros(len(start), bool), np.zeros(len(start), bool)
    any_[position], earlier[position] = same[:-1] | same[1:], same[:-1]
    edge = np.cumsum(count)[:-1]
    return tuple([np.packbits(x).tobytes() for x in np.split(bits, edge)] for bits in (any_, earlier))


FOUND = "row_id long, tag long, place long, windows int, any binary, earlier binary"


def ranked(rows: DataFrame) -> DataFrame:
    """Windows of the stretches that repeat, decided by suffix arrays of all stretches of an anchor together."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last, weight = None, 0

        def told() -> pa.RecordBatch:
            row, tag, place, stretch = zip(*held, strict=True)
            any_, earlier = suffix_neighbours(list(stretch), list(zip(row, place, strict=True)))
            return pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in (row, tag, place)), pa.array([len(x) - LENGTH + 1 for x in stretch], pa.int32()),
                 pa.array(any_, pa.binary()), pa.array(earlier, pa.binary())],
                ["row_id", "tag", "place", "windows", "any", "earlier"])

        for batch in batches:
            for key, *one in zip(*(batch.column(c).to_pylist() for c in ("key", "row_id", "tag", "place", "stretch")), strict=True):
                if key != last and weight >= RANKED:
                    yield told()
                    held, weight = [], 0
                held.append(one)
                last, weight = key, weight + len(one[-1])
        if held:
            yield told()

    return rows.where("not spread").repartition("key").sortWithinPartitions("key").mapInArrow(each, FOUND)


def counted(rows: DataFrame) -> DataFrame:
    """The same for anchors of very many stretches, by counting window hashes."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, tag, place, stretch in zip(*(batch.column(c).to_pylist() for c in ("row_id", "tag", "place", "stretch")), strict=True):
                start = np.arange(len(stretch) - LENGTH + 1)
                window = tb.Rolling(np.frombuffer(stretch, np.uint8)).each(LENGTH)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(window.view(np.int64)), *(pa.array(np.full(len(start), x)) for x in (row, tag, place)),
                     pa.array(start.astype(np.int32))], ["window", "row_id", "tag", "place", "step"])

    windows = rows.where("spread").mapInArrow(hashed, "window long, row_id long, tag long, place long, step int")
    at = F.struct("row_id", (F.col("place") + F.col("step")).alias("at"))
    known = windows.groupBy("window").agg(F.count("*").alias("n"), F.min(at).alias("first")).where("n > 1")
    hit = windows.join(known, "window").select("row_id", "tag", "place", "step", (at > F.col("first")).alias("later"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for steps, later in zip(batch.column("steps").to_pylist(), batch.column("later").to_pylist(), strict=True):
                any_, earlier = np.zeros((2, REACH), bool)
                any_[steps] = True
                earlier[steps] = later
                for x, value in zip(out, (REACH, np.packbits(any_).tobytes(), np.packbits(earlier).tobytes()), strict=True):
                    x.append(value)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row_id", "tag", "place")), pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())],
                ["row_id", "tag", "place", "windows", "any", "earlier"])

    per_stretch = hit.groupBy("row_id", "tag", "place").agg(F.collect_list("step").alias("steps"), F.collect_list("later").alias("later"))
    return per_stretch.mapInArrow(bits, FOUND)


def cut(texts: DataFrame, final: bool, keep_first: bool) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256. Before the end only rows without marks get them; others keep text and marks."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tb.slices(batches, "text", SLICE):
            gone = np.zeros(len(data), bool)
            marks = ex.joined_marks(rows.column("marks"), MARK)
            if final:
                found = Anchors(data, offsets)
                flags = marked(found, offsets, marks)
                whole = (flags & WHOLE) > 0
                if keep_first:
                    whole &= (flags & FIRST) == 0
                at = [np.concatenate([np.arange(a, b + 1) for a, b in zip(found.low[whole], found.high[whole], strict=True)] or [np.zeros(0, np.int64)])]
                for i, ranked_ in enumerate(rows.column("ranked").to_pylist()):
                    for r in ranked_ or ():
                        bits = np.unpackbits(np.frombuffer(r["earlier" if keep_first else "any"], np.uint8))[:r["windows"]]
                        at.append(np.flatnonzero(bits) + r["place"] + offsets[i])
                gone = tb.covered(np.concatenate(at), LENGTH, len(data))
            out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
            left = []
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                own = gone[a:b]
                out["n_bytes"].append(int(b - a))
                out["n_removed"].append(int(own.sum()))
                out["n_spans"].append(int((own & ~np.r_[False, own[:-1]]).sum()) if b > a else 0)
                waits = not final and len(marks[i]) > 0
                out["kept_sha256"].append(None if waits else hashlib.sha256(data[a:b][~own].tobytes()).hexdigest())
                left.append(data[a:b].tobytes().decode() if waits else None)
            made = [rows.column("doc_id"), *(pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string())]
            names = ["doc_id", *out]
            if not final:
                made += [rows.column("row_id"), rows.column("tag"), pa.array(left, pa.string()), rows.column("marks")]
                names += ["row_id", "tag", "text", "marks"]
            yield pa.RecordBatch.from_arrays(made, names)

    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return texts.mapInArrow(each, kinds + ", row_id long, tag long, text string, marks array<binary>" * (not final))


def deduplicated(docs: DataFrame, keep_first: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of every row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = own.withColumns({"row_id": F.coalesce("doc_id", F.xxhash64("text")), "tag": F.xxhash64("text")})
    bits = ex.bucket_count(own).bit_length() - 1
    found = met(anchors(rows, bits)).groupBy("row_id").agg(F.collect_list("marks").alias("marks"))
    first = kept_table(cut(rows.join(found, "row_id", "left"), False, keep_first), "anchored")
    opened = first.where("text is not null")
    pieces = kept_table(stretches(opened.select("row_id", "tag", "text", "marks")), "stretches")
    decided = ranked(pieces).unionAll(counted(pieces))
    per_row = decided.groupBy("row_id", "tag").agg(F.collect_list(F.struct("place", "windows", "any", "earlier")).alias("ranked"))
    closed = cut(opened.select("doc_id", "row_id", "tag", "text", "marks").join(per_row, ["row_id", "tag"], "left"), True, keep_first)
    return first.where("text is null").select(*closed.columns).unionAll(closed)
