"""Packing of documents into sequences along a space-filling curve.

A document's hashed vector is the sum of a random sign vector per token, in a few dimensions; its
direction has a place on a Hilbert curve, so neighbours on the curve use similar tokens. Documents are
sorted by range along the curve, prefix sums of their lengths give each its place in one long stream,
and the stream is cut every ``capacity`` ids. Only the last sequence has padding.

Texts are encoded once. The ids travel compressed; what is sorted is a narrow row per document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from needledrop.llm.common import partitions, ship
from needledrop.sources.store import settled

DIMENSIONS, BITS = 4, 12


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows) with ``bits`` bits a dimension.

    Bit planes are undone from the highest: each tells which axes swap and which turn in the planes below.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for axis in range(n):
            turned = (x[axis] >> level) & 1 == 1
            other = np.where(turned, 0, (x[0] ^ x[axis]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ other)
            x[axis] = np.where(turned & (axis > 0), x[axis], x[axis] ^ other) if axis else x[0]
    for axis in range(1, n):
        x[axis] ^= x[axis - 1]
    parity = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        parity ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= parity
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(n):
            place = (place << 1) | ((x[axis] >> level) & 1)
    return place


def signs(vocabulary: int, seed: int = 11) -> np.ndarray:
    """One random sign vector per token id."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), (vocabulary, DIMENSIONS))


def curve_places(sums: np.ndarray) -> np.ndarray:
    """Hilbert places of the directions of vectors; no direction is the middle of the cube."""
    size = np.linalg.norm(sums, axis=1, keepdims=True)
    unit = np.divide(sums, size, out=np.zeros_like(sums), where=size > 0)
    return hilbert(np.minimum((unit + 1) / 2 * (1 << BITS), (1 << BITS) - 1).astype(np.int64), BITS)


def _encode(tokenizer: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from needledrop.llm.vocab import id_type, library, word_ids

        kind, pack = id_type(tokenizer), zstandard.ZstdCompressor(level=1)
        table = signs(max(library(tokenizer).get_vocab_size(), end_id + 1))
        end = np.array([end_id], kind)
        for batch in batches:
            blobs, sizes, sums = [], [], []
            for text in batch.column("text"):
                ids = np.append(word_ids(tokenizer, text.as_py() or ""), end)
                blobs.append(pack.compress(ids.tobytes()))
                sizes.append(len(ids))
                sums.append(table[ids[:-1]].sum(axis=0))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"), "place": curve_places(np.array(sums, np.float64).reshape(-1, DIMENSIONS)),
                    "doc_tokens": pa.array(sizes, pa.int64()), "blob": pa.array(blobs, pa.binary()),
                }
            )

    return encode


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(tokenizer: str, capacity: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from needledrop.llm.vocab import id_type

        kind, unpack = id_type(tokenizer), zstandard.ZstdDecompressor()
        for batch in batches:
            out: dict[str, list] = {c: [] for c in [*(f.split()[0] for f in _PIECES.split(", ")), *["ids"] * with_ids]}
            for doc, at, blob in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "blob"))):
                ids = np.frombuffer(unpack.decompress(blob), kind).astype("<u4")
                start = 0
                while start < len(ids):
                    sequence, offset = divmod(at + start, capacity)
                    piece = ids[start : start + capacity - offset]
                    row = (doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), sequence, offset)
                    for name, value in zip(out, (*row, *[piece] * with_ids)):
                        out[name].append(value)
                    start += len(piece)
            yield pa.RecordBatch.from_pydict(
                {c: pa.array(v, pa.list_(pa.int64()) if c == "ids" else pa.int64()) for c, v in out.items()}
            )

    return cut


def pack(
    docs: DataFrame, capacity: int = 2048, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, with_ids: bool = True
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is its ids and ``end_id``; each id lies in one piece. Sequences are full but for the last one.
    Null and empty texts are the end id alone. Repeated rows are packed as often as they occur; equal
    places keep the order of doc_id. Other columns are ignored; no documents give no pieces.
    """
    spark = docs.sparkSession
    ship(spark)
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = narrow.mapInArrow(_encode(tokenizer, end_id), "doc_id long, place long, doc_tokens long, blob binary")
    # Row ids are written with the rows, so every later pass sees the same ones.
    encoded = settled(encoded.withColumn("row", F.monotonically_increasing_id()), "packing-ids")
    curve = ["place", "doc_id", "row"]
    ranged = encoded.select(*curve, "doc_tokens").repartitionByRange(partitions(docs), *curve)
    ranged = settled(ranged.withColumn("part", F.spark_partition_id()), "packing-order")
    # One row per range: few, and summed in order.
    parts = ranged.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.cast("bigint").alias("begin"))
    inside = W.partitionBy("part").orderBy(*curve).rowsBetween(W.unboundedPreceding, -1)
    placed = ranged.withColumn("at", F.coalesce(F.sum("doc_tokens").over(inside), F.lit(0)))
    placed = placed.join(F.broadcast(parts), "part").select("row", (F.col("at") + F.col("begin")).cast("bigint").alias("at"))
    pieces = encoded.select("row", "doc_id", "blob").join(placed, "row").select("doc_id", "at", "blob")
    return pieces.mapInArrow(_cut(tokenizer, capacity, with_ids), _PIECES + ", ids array<long>" * with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed sequences themselves, from pieces with ids."""
    part = F.struct("offset", "ids", "doc_id")
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
