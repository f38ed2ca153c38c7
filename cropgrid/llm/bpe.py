"""BPE encoding and decoding by batched merge rounds.

The pieces of many texts are collected, and the symbols of all new distinct ones lie in one flat array. In a round every
neighbouring pair is looked up by binary search over the sorted pair keys; each piece merges all places of its
lowest-ranked pair, left to right; the array is packed. Rounds go on with the pieces that changed.

Defined cases: a null or empty text has no tokens. The texts of added tokens (such as <|endoftext|>) are one token,
as the vocabulary file says. Long pieces are merged like short ones, whole. Repeated rows each get their row.
Ids outside the vocabulary decode to nothing; bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cropgrid.llm import textbytes as tb

#: Fixed value: the pattern that splits texts for byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered from one slice to the next; beyond that the memory starts anew.
KEPT = 200_000


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_signs() -> dict[str, int]:
    """The printable sign by which byte-level vocabularies write each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Bpe:
    """A vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        signs, vocab = byte_signs(), spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(signs[c] for c in token)
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.added = added
        self.around = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.split = regex.compile(SPLIT)
        self.byte_ids = np.zeros(256, np.int64)
        for sign, b in signs.items():
            self.byte_ids[b] = vocab[sign]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order, made[order]
        self.known: dict[str, np.ndarray] = {}

    def merge(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of each piece."""
        raw = [p.encode() for p in pieces]
        lengths = np.array([len(r) for r in raw], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        never = np.iinfo(np.int64).max
        while len(symbols):
            keys = symbols[:-1] << 32 | symbols[1:]
            place = np.searchsorted(self.keys, keys)
            place[place == len(self.keys)] = 0
            hit = (self.keys[place] == keys) & (owner[1:] == owner[:-1])
            rank = np.full(len(symbols), never)
            rank[:-1][hit] = self.ranks[place[hit]]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(owner)])
            over = np.repeat(least == never, sizes)
            chosen = (rank == np.repeat(least, sizes)) & ~over
            at = np.flatnonzero(chosen)
            if len(at):  # in a chain of overlapping places every other one merges, from the left
                start = np.r_[True, np.diff(at) > 1]
                nth = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                at = at[nth % 2 == 0]
                symbols = symbols.copy()
                symbols[at] = self.made[place[at]]
            keep = ~over
            keep[at + 1] = False
            done.append((owner[over], symbols[over]))
            symbols, owner = symbols[keep], owner[keep]
        if not done:
            return [np.zeros(0, np.int64) for _ in raw]
        owners, ids = np.concatenate([o for o, _ in done]), np.concatenate([s for _, s in done])
        order = np.argsort(owners, kind="stable")
        return np.split(ids[order], np.cumsum(np.bincount(owners, minlength=len(raw)))[:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the tokenizers library gives them without special tokens of its own."""
        cut = []
        for text in texts:
            if self.around is None or not self.around.search(text):
                cut.append(self.split.findall(text))
            else:
                cut.append([p for part in self.around.split(text) if part
                            for p in ([(part,)] if part in self.added else self.split.findall(part))])
        if len(self.known) > KEPT:
            self.known.clear()
        new = list({p: None for pieces in cut for p in pieces if p not in self.known})
        plain = [p for p in new if isinstance(p, str)]
        for token in new:
            if not isinstance(token, str):
                self.known[token] = np.array([self.added[token[0]]], np.int64)
        self.known.update(zip(plain, self.merge(plain), strict=True))
        empty = np.zeros(0, np.int64)
        return [np.concatenate([self.known[p] for p in pieces]) if pieces else empty for pieces in cut]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids if 0 <= i < len(self.bytes_of)).decode("utf-8", "replace")


_open: dict[str, Bpe] = {}


def opened(path: str) -> Bpe:
    """The vocabulary, read once by each Python worker."""
    if path not in _open:
        _open[path] = Bpe(path)
    return _open[path]


def encoded(docs: DataFrame, path: str | None = None, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, ids (if kept), n_tokens, ids_sha256 and decoded_sha256 of every text. `path` must be readable by executors."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(path or vocabulary_path())
        for rows, data, offsets in tb.slices(batches, "text"):
            raw = data.tobytes()
            ids = bpe.encode([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            out = {"doc_id": rows.column("doc_id")}
            if keep_ids:
                out["ids"] = pa.array(ids, pa.list_(pa.int32()))
            out["n_tokens"] = pa.array([len(x) for x in ids], pa.int64())
            out["ids_sha256"] = pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids])
            out["decoded_sha256"] = pa.array([hashlib.sha256(bpe.decode(x.tolist()).encode()).hexdigest() for x in ids])
            yield pa.RecordBatch.from_pydict(out)

    from pyspark.sql import functions as F

    own = docs.select("doc_id", F.col(text).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(each, f"doc_id {kind}, " + "ids array<int>, " * keep_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string")


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of the column `ids`; null ids give an empty text."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(path or vocabulary_path())
        for batch in batches:
            texts = [bpe.decode([i for i in ids or () if i is not None]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    own = tokens.select("doc_id", "ids")
    return own.mapInArrow(each, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text string")
