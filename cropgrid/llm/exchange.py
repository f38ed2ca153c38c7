"""Hashes of many positions sent to where equal ones meet, packed by bucket.

A slice of texts gives one row for each bucket: the hashes that fall into it, in order of documents, with the
documents' ids and counts. A row costs a few bytes a hash and nothing else, and the receiving task works on arrays.
Buckets are cut by the high bits of the hash, so their number follows the input and each stays of a bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of input for each bucket.
BUCKET_BYTES = 32 << 20
SCHEMA = "bucket int, indexed boolean, docs binary, counts binary, prints binary"


def bucket_count(docs: DataFrame) -> int:
    """From the size of the scanned files as the optimizer knows it; a power of two."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(8, 1 << min(20, (max(1, size) // BUCKET_BYTES).bit_length()))


def packed(bucket: np.ndarray, doc: np.ndarray, prints: np.ndarray, indexed: np.ndarray) -> dict[str, list]:
    """Rows of SCHEMA for the entries of one slice. `prints` may have several columns."""
    rows: dict[str, list] = {name: [] for name in ("bucket", "indexed", "docs", "counts", "prints")}
    order = np.lexsort((doc, indexed, bucket))
    bucket, doc, prints, indexed = bucket[order], doc[order], prints[order], indexed[order]
    edge = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (indexed[1:] != indexed[:-1])]) if len(bucket) else []
    for a, b in zip(edge, [*edge[1:], len(bucket)], strict=True):
        start = np.flatnonzero(np.r_[True, doc[a + 1:b] != doc[a:b - 1]])
        rows["bucket"].append(int(bucket[a]))
        rows["indexed"].append(bool(indexed[a]))
        rows["docs"].append(doc[a:b][start].astype(np.int64).tobytes())
        rows["counts"].append(np.diff(np.r_[start, b - a]).astype(np.int32).tobytes())
        rows["prints"].append(np.ascontiguousarray(prints[a:b]).tobytes())
    return rows


def batch_of(rows: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(rows["bucket"], pa.int32()), pa.array(rows["indexed"], pa.bool_()), *(pa.array(rows[c], pa.binary()) for c in ("docs", "counts", "prints"))],
        ["bucket", "indexed", "docs", "counts", "prints"])


def unpacked(docs: bytes, counts: bytes, prints: bytes, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Documents and hashes, entry by entry."""
    return np.repeat(np.frombuffer(docs, np.int64), np.frombuffer(counts, np.int32)), np.frombuffer(prints, kind)


def ordered(rows: DataFrame) -> DataFrame:
    """Rows of a bucket one after the other in one task, those of the index first."""
    from pyspark.sql import functions as F

    return rows.repartition("bucket").sortWithinPartitions("bucket", F.desc("indexed"))


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of SCHEMA one by one, their bytes as views of the batch."""
    for batch in batches:
        bucket, indexed = (batch.column(c).to_pylist() for c in ("bucket", "indexed"))
        columns = [batch.column(c) for c in ("docs", "counts", "prints")]
        for i in range(batch.num_rows):
            yield bucket[i], indexed[i], *(c[i].as_buffer() for c in columns)


def per_doc(doc: np.ndarray, marks: np.ndarray, head: bytes = b"") -> pa.RecordBatch:
    """One row for each document: doc_id and its marks as bytes, after `head`."""
    order = np.argsort(doc, kind="stable")
    doc, marks = doc[order], marks[order]
    start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[start]), pa.array([head + np.ascontiguousarray(marks[a:b]).tobytes() for a, b in zip(start, np.r_[start, len(doc)][1:], strict=True)], pa.binary())],
        ["doc_id", "marks"])


def gathered(marks: DataFrame) -> DataFrame:
    """doc_id and all marks of each document, which are no more than the document has positions."""
    from pyspark.sql import functions as F

    return marks.groupBy("doc_id").agg(F.collect_list("marks").alias("marks"))


def joined_marks(column: pa.Array, kind: type) -> list[np.ndarray]:
    """The marks of each row as one array."""
    return [np.concatenate([np.frombuffer(m, kind) for m in row]) if row else np.zeros(0, kind) for row in column.to_pylist()]
