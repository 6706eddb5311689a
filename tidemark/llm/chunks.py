"""Documents in chunks, and questions about corpus-wide counts that chunks ask by hash.

A chunk is one row with some thousand documents, its texts compressed. Instead of exploding every
word of the corpus into rows, a task that reads a chunk asks once for each distinct key in it, as one
packed blob per part of the key space; a part is answered by one task, which sees all chunks' blobs for
it and replies to each chunk in the order of its question. A key in a third of all documents is thus
asked once per chunk, not once per document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

CHUNK = "chunk string, n_bytes long, ids array<long>, sizes binary, texts binary"
_FIELDS = pa.schema([("chunk", pa.string()), ("n_bytes", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("texts", pa.binary())])

#: Bytes of text in a chunk, and bytes of keys that one part may hold.
CHUNK_BYTES, PART_BYTES = 8 << 20, 24 << 20


def chunked(docs: DataFrame, scratch: Scratch, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs (doc_id, text) as a table of chunks in scratch; null text: empty. Within a chunk documents are
    ordered by doc_id, null last."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[bytes] = []
        held = 0

        def full() -> pa.RecordBatch:
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            own = [texts[i] for i in order]
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(own))
            sizes = np.array([len(x) for x in own], np.int64).tobytes()
            row = {"chunk": [uuid.uuid4().hex], "n_bytes": [held], "ids": [[ids[i] for i in order]], "sizes": [sizes], "texts": [blob]}
            return pa.RecordBatch.from_pydict(row, schema=_FIELDS)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                texts.append((text.as_py() or "").encode("utf-8", "surrogatepass"))
                held += len(texts[-1])
                if held >= chunk_bytes:
                    yield full()
                    ids, texts, held = [], [], 0
        if ids:
            yield full()

    return scratch.store(docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(pack, CHUNK), packed=True, texts=True)


def unpack(ids, sizes: bytes, texts: bytes) -> tuple[list[int | None], list[bytes]]:
    """A chunk's documents."""
    ends = np.cumsum(np.frombuffer(sizes, np.int64))
    blob = zstandard.ZstdDecompressor().decompress(texts, max_output_size=int(ends[-1]) if len(ends) and ends[-1] else 1)
    return list(ids), [blob[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def part_count(chunks: DataFrame, bytes_per_text_byte: float, part_bytes: int = PART_BYTES) -> int:
    """Parts of the key space, so that none holds more than about part_bytes."""
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    least = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, int(total * bytes_per_text_byte / part_bytes) + 1)


def part_bounds(parts: int) -> np.ndarray:
    """Lowest key of each part after the first: equal ranges of 64-bit keys."""
    return np.array([(1 << 64) * p // parts for p in range(1, parts)], np.uint64)


def pack_keys(keys: np.ndarray, size: int = 7) -> bytes:
    """The low bytes of 64-bit keys: seven, as within a part of the key space the eighth adds little; fewer
    where keys are only told apart inside a small group."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def unpack_keys(blob: bytes, size: int = 7) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, size)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :size] = raw
    return out.view(np.uint64).reshape(-1)


def planes(values: np.ndarray) -> bytes:
    """Numbers with their low bytes first, then their next bytes and so on: small numbers compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def unplanes(blob: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)
