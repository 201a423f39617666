"""Blocks of documents that ask buckets.

Some operators must know, for each of a document's many hashes, what the whole
corpus has under it. A row for each hash would move far more than the texts, so
documents are dealt into blocks of bounded bytes. A block packs its distinct
hashes into one array for each bucket of hashes, the bucket answers with an
array in the same order, and the block reads its answers beside its documents.
A hash that stands in a third of all documents is one entry of each block, so
no bucket is hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelforge.llm.common import bounded_batches

#: Bytes of text in a block; more only if there would be over MOST_BLOCKS.
BLOCK_BYTES = 3 << 20
MOST_BLOCKS = 1 << 18
MOST_BUCKETS = 1 << 16


def blocked(docs: DataFrame, *extra: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(block, doc_id, packed, extra...) and the number of blocks: each row of
    ``docs`` with its text (null: empty) in UTF-8, compressed."""
    bounded_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = min(MOST_BLOCKS, total // block_bytes + 1)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")

    def pack(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            packed = [z.compress((t.as_py() or "").encode()) for t in b.column("text")]
            yield pa.record_batch([b.column("block"), b.column("doc_id"), pa.array(packed, pa.binary()),
                                   *(b.column(c) for c in extra)], ["block", "doc_id", "packed", *extra])

    from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

    schema = StructType([StructField("block", IntegerType()), docs.schema["doc_id"], StructField("packed", BinaryType()),
                         *(docs.schema[c] for c in extra)])
    return docs.select(block.alias("block"), "doc_id", "text", *extra).mapInArrow(pack, schema), blocks


def texts(table: pa.Table) -> list[bytes]:
    import zstandard

    z = zstandard.ZstdDecompressor()
    return [z.decompress(p.as_py()) for p in table.column("packed")]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of unsigned 64-bit hashes, in the hashes' order."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def by_bucket(h: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of each bucket's part of the sorted hashes."""
    b = bucket_of(h, buckets)
    cut = np.flatnonzero(np.diff(b)) + 1
    edges = [0, *cut.tolist(), len(h)]
    return [(int(b[x]), x, y) for x, y in zip(edges, edges[1:]) if y > x]
