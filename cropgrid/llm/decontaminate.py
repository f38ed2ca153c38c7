"""Benchmark decontamination: approximate occurrences of benchmark items, by the q-gram lemma.

Texts and items are normalised: A-Z and the accented letters of Latin-1 in lower case, each run of other ASCII signs than letters and digits one space. An
occurrence of an item of m bytes with e edits at most shares at least m + 1 - Q * (e + 1) of its Q-grams, all on diagonals (place
in the text less place in the item) that differ by e at most. So the shared grams are counted in bands of 2 * (e + 1)
diagonals that overlap by half; bands with enough of them are kept, and a banded alignment decides. The budget is one edit for each
EDIT_BYTES bytes.

Items travel to the tasks in blocks of BLOCK_BYTES at most, one pass over the texts for each block, so a broadcast is of
bounded size whatever the benchmark's.

Defined cases: null texts are empty and have no matches. Items of fewer than LEAST normalised bytes, null ones among them, are too
short to tell anything and match nothing. Of several matches of an item in a text the one with the fewest edits, then the first, is
reported. Repeated rows, items and ids each get their own matches. Without items or rows nothing is reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropgrid.llm import textbytes as tb

Q, EDIT_BYTES, LEAST = 12, 20, 32
BLOCK_BYTES = 4 << 20

PLAIN = tb.LOWER.copy()
for _b in range(0x80):
    if not chr(_b).isalnum():
        PLAIN[_b] = 0x20


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes of all texts, their offsets, and the place each byte had."""
    plain = PLAIN[data]
    accented = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    plain[accented] += 0x20
    gap = plain == 0x20
    again = np.r_[False, gap[:-1]] if len(gap) else gap
    again[offsets[:-1][offsets[:-1] < len(data)]] = False
    place = np.flatnonzero(~(gap & again))
    return plain[place], np.searchsorted(place, offsets), place


class Items:
    """A block of the benchmark: normalised items and their grams, sorted by hash."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.texts = [], []
        for i, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            plain = normalised(raw, np.array([0, len(raw)]))[0].tobytes().strip(b" ")
            if len(plain) >= LEAST:
                self.ids.append(i)
                self.texts.append(plain)
        size = np.array([len(t) for t in self.texts], np.int64)
        self.size, self.budget = size, size // EDIT_BYTES
        self.need = size + 1 - Q * (self.budget + 1)
        begin = np.cumsum(size) - size
        item = np.repeat(np.arange(len(size)), size - Q + 1)
        place = np.arange(len(item)) - np.repeat(np.cumsum(size - Q + 1) - (size - Q + 1), size - Q + 1)
        data = np.frombuffer(b"".join(self.texts), np.uint8)
        start = begin[item] + place
        key = tb.Rolling(data).of(start, start + Q) if len(data) else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.place = key[order], item[order], place[order]
        self.lead = np.flatnonzero(np.r_[True, self.key[1:] != self.key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.count = np.diff(np.r_[self.lead, len(key)])
        self.keys = self.key[self.lead]
        self.maybe = np.zeros(1 << 22, bool)  # a first look by the low bits
        self.maybe[(self.keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def regions(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Text, item, and the first and last diagonal of each band with enough shared grams."""
        places = np.arange(max(0, len(data) - Q + 1))
        key = tb.Rolling(data).of(places, places + Q)
        at = np.flatnonzero(self.maybe[(key & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return
        found = np.searchsorted(self.keys, key[at])
        found[found == len(self.keys)] = 0
        hit = self.keys[found] == key[at]
        at, found = at[hit], found[hit]
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + Q <= offsets[text + 1]
        at, found, text = at[inside], found[inside], text[inside]
        times = self.count[found]
        which = np.repeat(self.lead[found], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        at, text, item = np.repeat(at, times), np.repeat(text, times), self.item[which]
        diagonal = at - self.place[which] + len(data)  # never negative
        half = self.budget[item] + 1
        band = diagonal // half
        most = 4 * len(data) + 4
        label = (text * len(self.ids) + item) * most + band
        for step in (0, 1):  # band b holds the diagonals of half bands b and b + 1
            each, size = np.unique(label - step, return_counts=True)
            if step == 0:
                low, n_low = each, size
            else:
                every = np.union1d(low, each)
        total = np.zeros(len(every), np.int64)
        total[np.searchsorted(every, low)] += n_low
        total[np.searchsorted(every, each)] += size
        pair = every // most
        kept = total >= self.need[pair % len(self.ids)]
        for value in every[kept].tolist():
            pair, band = divmod(value, most)
            text, item = divmod(pair, len(self.ids))
            half = int(self.budget[item]) + 1
            yield text, item, band * half - len(data), (band + 2) * half - 1 - len(data)


def aligned(pattern: np.ndarray, text: np.ndarray, low: int, high: int, anchored: bool) -> np.ndarray:
    """Least edits between the whole pattern and a part of the text that ends at each column, in the band of diagonals low..high.

    Free to begin anywhere, or (anchored) at the text's start only. Column c of the result is the end low + len(pattern) + c.
    """
    width = high - low + 1
    far = 1 << 30
    column = np.arange(width)
    place = low + column
    row = np.where((place >= 0) & (place <= len(text)), np.abs(place) if anchored else 0, far).astype(np.int64)
    for i, sign in enumerate(pattern.tolist()):
        place = low + i + column  # of the sign that the diagonal compares
        inside = (place >= 0) & (place < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[place[inside]] == sign
        step = row + ~same
        step[~inside] = far
        gap = np.r_[row[1:], far] + 1  # a sign of the pattern that the text lacks
        step = np.minimum(step, gap)
        step[(place + 1 < 0) | (place + 1 > len(text))] = far
        row = np.minimum.accumulate(step - column) + column
        row[(place + 1 < 0) | (place + 1 > len(text))] = far
    return row


def located(pattern: bytes, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Edits, start and end of the best occurrence on the diagonals low..high (one budget wider), if within the budget."""
    low, high = low - budget, high + budget
    own = np.frombuffer(pattern, np.uint8)
    exact = text[max(0, low):max(0, high + len(own) + 1)].tobytes().find(pattern)
    if exact >= 0:
        return 0, max(0, low) + exact, max(0, low) + exact + len(own)
    ends = aligned(own, text, low, high, anchored=False)
    best = int(ends.argmin())
    edits = int(ends[best])
    if edits > budget:
        return None
    end = low + len(own) + best
    back = aligned(own[::-1], text[:end][::-1], -edits, edits, anchored=True)
    return edits, end - (len(own) - edits + int(back.argmin())), end


MATCH = "array<struct<item_id:long,start:long,end:long,edits:long>>"


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items, so many at a time as fit in BLOCK_BYTES (or one)."""
    held, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        if held and size + len(text or "") > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append((item, text))
        size += len(text or "")
    if held:
        yield held


def marked(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Every row of `docs` as the struct `doc` (of the columns `keep`, or all) with `matches`; start and end are bytes of the text."""
    names = docs.columns if keep is None else keep
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc"), F.col(text).cast("string").alias("text"),
                      F.array().cast(MATCH).alias("matches"))
    kind = out.schema["doc"].dataType.simpleString()
    for rows in blocks(benchmark):
        out = out.mapInArrow(_searched(docs.sparkSession.sparkContext.broadcast(Items(rows))), f"doc {kind}, text string, matches {MATCH}")
    return out.select("doc", "matches")


def _searched(items):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = items.value
        for rows, data, offsets in tb.slices(batches, "text"):
            plain, ends, place = normalised(data, offsets)
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for text, item, low, high in known.regions(plain, ends):
                a, b = int(ends[text]), int(ends[text + 1])
                found = located(known.texts[item], plain[a:b], low - a, high - a, int(known.budget[item]))
                if found and found < best.get((text, item), (1 << 40,)):
                    best[text, item] = found
            matches = [list(m or ()) for m in rows.column("matches").to_pylist()]
            for (text, item), (edits, start, end) in sorted(best.items()):
                shift = int(ends[text])
                first = int(place[shift + start]) if shift + start < len(place) else int(offsets[text + 1])
                last = int(place[shift + end - 1]) + 1
                matches[text].append({"item_id": known.ids[item], "start": first - int(offsets[text]), "end": last - int(offsets[text]), "edits": edits})
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "start", "end", "edits")]))
            yield pa.RecordBatch.from_arrays([rows.column("doc"), rows.column("text"), pa.array(matches, kind)], ["doc", "text", "matches"])

    return each
